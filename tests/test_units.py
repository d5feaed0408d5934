"""Literal cases and ladder boundaries."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollcall.functions import scalar, tables
from rollcall.operators import aggregate, clean, features, joins, policy, scoring
from rollcall.sources import readers


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_column_aliases():
    got = clean.column_mapping(["State_Name", "DISTRICT", "Male_Count", "Female_Count"])
    assert got == {"State_Name": "state", "DISTRICT": "district", "Male_Count": "male_enrolled", "Female_Count": "female_enrolled"}


def test_coverage_and_gap(spark):
    df = spark.createDataFrame([(1000, 900), (1000, 800)], "male bigint, female bigint")
    rows = aggregate.gender_ratios(df).orderBy(F.desc("female")).collect()
    assert rows[0]["female_ratio"] == pytest.approx(0.473684, abs=1e-6)
    assert rows[1]["gender_gap"] == pytest.approx(0.1111, abs=1e-4)


def test_median_impute(spark):
    df = spark.createDataFrame([(1.0, 10.0), (2.0, 20.0), (None, 30.0), (4.0, None)], "a double, b double")
    rows = clean.impute_global(df, ["a", "b"]).collect()
    assert sorted(r["a"] for r in rows) == [1.0, 2.0, 2.0, 4.0] and sorted(r["b"] for r in rows) == [10.0, 20.0, 20.0, 30.0]


def test_unified_risk(spark):
    df = spark.createDataFrame([("k", "behavioral_baseline", 0.45, 0.8, 500), ("k", "operator_profiling", 0.62, 0.8, 500)],
                               "k string, strategy string, raw_score double, confidence double, records_analyzed bigint")
    r = policy.unified_risk(df, ["k"], "enhanced").first()
    assert (r["risk_index"], r["risk_level"]) == (62, "High")


def test_penetration_and_efficiency(spark):
    df = spark.createDataFrame([("Karnataka", f"d{m}", dt.date(2025, m, 1), 24804, 0, 0) for m in range(1, 9)] + [("Karnataka", "d9", dt.date(2025, 9, 1), 24803, 0, 0)],
                               "state string, district string, date date, age_0_5 bigint, age_5_17 bigint, age_18_greater bigint")
    p = aggregate.penetration(df, spark.createDataFrame([("Karnataka", 61095297)], "state string, population bigint"))
    r = p.first()
    assert r["total"] == 223235 and r["penetration_pct"] == pytest.approx(0.365388, abs=5e-7) and r["monthly_velocity"] == 24804
    assert aggregate.enrolment_efficiency(p).first()["eei"] == pytest.approx(1.0)
    assert 223235 / 271164 == pytest.approx(0.8232, abs=5e-5)


def test_z_ladders(spark):
    z = lambda v, s: one(spark, z=v).select(scalar.classify_z(F.col("z"), s)).first()[0]
    assert [z(v, "a") for v in (3.1, 3.0, 1.96, -1.96, -2.0)] == ["Anomaly", "Hot Spot", "In-Sync", "In-Sync", "Cold Spot"]
    assert [z(v, "b") for v in (2.58, 1.66, -1.65, -2.58)] == ["Hot Spot", "Emerging Trend", "Declining", "High Exclusion Zone"]
    assert [z(v, "c") for v in (2.59, 2.58, -2.58, -1.96)] == ["Significant Hotspot", "Emerging Trend", "Declining", "In-Sync"]
    assert [z(v, "d") for v in (2.6, -2.0, 1.7, 1.6)] == ["hotspot_99", "coldspot_95", "hotspot_90", "not_significant"]
    assert [z(v, "e") for v in (2.6, -2.0, 1.7)] == ["hotspot_99", "coldspot_95", "not_significant"]


def test_risk_bins(spark):
    got = [one(spark, s=v).select(scalar.risk_category(F.col("s"))).first()[0] for v in (0.0, 0.3, 0.30001, 0.8, 1.0, 1.01)]
    assert got == [None, "Low", "Medium", "High", "Critical", None]


def test_normal_cdf(spark):
    r = one(spark, x=1.96).select(scalar.normal_cdf(F.col("x")), scalar.normal_cdf(-F.col("x"))).first()
    assert r[0] == pytest.approx(0.9750021, abs=2e-7) and r[0] + r[1] == pytest.approx(1.0)


def test_state_names(spark):
    df = spark.createDataFrame([("WEST BANGAL",), ("WESTBENGAL",), ("100000",), ("ANDAMAN & NICOBAR ISLANDS",), ("Andaman and Nicobar  Islands ",)], "s string")
    got = [r["state_clean"] for r in clean.normalize_state(df, "s").collect()]
    assert got == ["West Bengal", "West Bengal", None, "Andaman And Nicobar Islands", "Andaman And Nicobar Islands"]


def test_dispositions(spark):
    d = lambda v, t: one(spark, s=v).select(policy.disposition(F.col("s"), t)).first()[0]
    assert [d(v, "balanced") for v in (0.9, 0.7, 0.5, 0.49)] == ["ESCALATE", "FLAG", "REVIEW", "CLEAR"]
    assert [d(0.85, t) for t in ("conservative", "aggressive")] == ["ESCALATE", "FLAG"]


def test_time_range_fallback(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1),)], "d date")
    assert clean.filter_time_range(df, "d", "today", "2024-01-01").count() == 0
    r = clean.filter_time_range(df, "d", "today", "2024-01-01", fallback=True).first()
    assert r["range_note"] == "unfiltered"


def test_label_encode_unseen(spark):
    fit = spark.createDataFrame([("b",), ("a",), ("a",)], "c string")
    table = clean.encoding_table(fit, "c")
    got = {r["c"]: r["c_code"] for r in clean.label_encode(spark.createDataFrame([("a",), ("b",), ("z",)], "c string"), "c", table).collect()}
    assert got == {"a": 1, "b": 2, "z": 0}


def test_union_when_nothing_shared(spark):
    a, b = spark.createDataFrame([(1,)], "x bigint"), spark.createDataFrame([(2,)], "y bigint")
    assert joins.join_common_keys({"a": a, "b": b}).count() == 2


def test_score_without_quality_uses_frequency(spark):
    df = spark.createDataFrame([("a", 0.5, 0.5, 0.1, 0.1, 0, 1.0), ("b", 0.5, 0.5, 0.1, 0.1, 0, 9.0)],
                               "state string, biometric_update_ratio double, demographic_update_ratio double, elderly_ratio double, age_65_plus_ratio double, is_high_risk_state int, update_frequency double")
    r = {x["state"]: x["risk_score"] for x in scoring.biometric_risk_score(df, F.lit(0), F.lit(1), quality=False).collect()}
    assert r["a"] - r["b"] == pytest.approx(0.1, abs=1e-6)


def test_flat_series_and_empty_features(spark):
    df = spark.createDataFrame([(1.0, 1.0, 1.0)], "a double, b double, c double")
    r = features.feat_row_stats(df, ["a", "b", "c"]).first()
    assert (r["row_std"], r["row_skew"], r["row_kurtosis"]) == (0.0, 0.0, 0.0)


def test_json_pages_and_csv(spark, tmp_path):
    (tmp_path / "p1.json").write_text('{"total":3,"count":2,"records":[{"s":"a","n":"1"},{"s":"b","n":null}]}')
    (tmp_path / "p2.json").write_text('{"total":3,"count":1,"records":[{"s":"c","n":"3"}]}')
    rec = T.StructType([T.StructField("s", T.StringType()), T.StructField("n", T.StringType())])
    assert sorted(r["s"] for r in readers.read_record_pages(spark, str(tmp_path / "*.json"), rec).collect()) == ["a", "b", "c"]
    (tmp_path / "t.csv").write_text("A,B,C\nx,1,\ny,,2.5\n")
    schema = T.StructType([T.StructField("A", T.StringType()), T.StructField("B", T.LongType()), T.StructField("C", T.DoubleType())])
    rows = readers.read_typed_csv(spark, str(tmp_path / "t.csv"), schema, zero=["B"]).orderBy("A").collect()
    assert [tuple(r) for r in rows] == [("x", 1, None), ("y", 0, 2.5)]


def test_tables_agree():
    assert set(tables.SIGNAL_WEIGHTS) == {s for v in tables.INTENT_SIGNALS.values() for s in v}
    assert set(tables.STRATEGY_WEIGHTS) == set(tables.STRATEGIES) == set(tables.STRATEGY_METHODS)


def test_state_spellings(spark):
    names = ["Jammu & Kashmir", "jammu and kashmir", "ANDAMAN & NICOBAR", "WEST BANGAL", "Pondicherry", "100000"]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = {r["s"]: r["state_clean"] for r in clean.normalize_state(df, "s").collect()}
    assert got["Jammu & Kashmir"] == got["jammu and kashmir"] == "Jammu & Kashmir"
    assert (got["ANDAMAN & NICOBAR"], got["WEST BANGAL"], got["Pondicherry"], got["100000"]) == (
        "Andaman And Nicobar Islands", "West Bengal", "Puducherry", None)


def test_unknown_is_numbered_among_the_classes(spark):
    fitted = spark.createDataFrame([("A",), ("Z",), ("a",)], "c string")
    codes = {r["c"]: r["c_code"] for r in clean.label_encode(fitted, "c").collect()}
    assert codes == {"A": 0, "Z": 2, "a": 3}
    other = clean.label_encode(spark.createDataFrame([("new",), (None,)], "c string"), "c", clean.encoding_table(fitted, "c"))
    assert {r["c_code"] for r in other.collect()} == {1}


def test_shares_are_of_the_total(spark):
    df = spark.createDataFrame([(200, 103, 98), (0, 0, 0)], "total bigint, male bigint, female bigint")
    rows = aggregate.gender_ratios(df).orderBy(F.desc("total")).collect()
    assert (rows[0]["male_ratio"], rows[0]["female_ratio"], rows[0]["gender_gap"]) == (0.515, 0.49, 0.025)
    assert (rows[1]["male_ratio"], rows[1]["female_per_male"]) == (0.0, 0.0)


def test_strategy_ties_keep_signal_order(spark):
    for intent, signals in tables.INTENT_SIGNALS.items():
        scores = {}
        for s in signals:
            for name in tables.SIGNAL_STRATEGIES.get(s, ()):
                scores[name] = scores.get(name, 0) + 1
        want = sorted(scores.items(), key=lambda kv: kv[1], reverse=True)[:3]
        df = spark.createDataFrame([(1, intent, "routine")], "id int, intent string, vigilance string")
        rows = policy.recommend_strategies(df, ["id"]).orderBy("rank").collect()
        assert [(r["strategy"], r["score"]) for r in rows] == ([(k, float(v)) for k, v in want] or [("behavioral_baseline", 0.0)])


def test_donors_fill_the_gaps(spark):
    from rollcall.operators import spatial
    rows = [(0, 0.0, 0.0, None), (1, 0.1, 0.0, None), (2, 1.0, 0.0, 10.0), (3, 2.0, 0.0, 20.0), (4, 9.0, 0.0, 90.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double, v double")
    got = {r["id"]: r["v"] for r in spatial.impute_knn(df, "id", "x", "y", "v", 2).collect()}
    assert (got[0], got[1], got[4]) == (15.0, 15.0, 90.0)


def test_drift_of_a_hot_key_over_many_batches(spark, tmp_path):
    """One key holds half of the rows, events come late and in many files; the stream agrees with the batch and with plain lists."""
    import random
    import statistics

    from rollcall.streaming import jobs
    rng = random.Random(3)
    rows = [(i, rng.randint(0, 10_000), "hot" if i % 2 else f"k{i % 6}", rng.random() + (i > 700)) for i in range(1000)]
    df = spark.createDataFrame(rows, "event_id long, at long, kind string, value double").withColumn("ts", F.timestamp_seconds("at"))
    df.repartition(7).write.parquet(str(tmp_path / "in"))
    stream = jobs.read_events(spark, str(tmp_path / "in"), files_per_trigger=1)
    got = {r["key"]: r for r in jobs.stream_drift(stream, "kind", "event_id", "value", 100, 0.1).collect()}
    batch = {r["kind"]: r for r in jobs.batch_drift(df, "kind", "ts", "event_id", "value", 100, 0.1).collect()}
    assert set(got) == set(batch) == {"hot", "k0", "k2", "k4"}
    for key, r in got.items():
        mine = [v for _, _, k, v in sorted(rows, key=lambda x: (x[1], x[0])) if k == key][-200:]
        assert (r["n"], r["enough"]) == (len(mine), len(mine) == 200) == (batch[key]["n"], batch[key]["enough"])
        if len(mine) == 200:
            old, new = mine[:100], mine[100:]
            mag = (abs(statistics.fmean(new) - statistics.fmean(old)) + abs(statistics.pstdev(new) - statistics.pstdev(old))) / 2
            assert abs(r["magnitude"] - mag) < 1e-9 and r["is_drift"] == (mag > 0.1) and abs(batch[key]["magnitude"] - mag) < 1e-9
        else:
            assert r["magnitude"] is None and r["is_drift"] is False
