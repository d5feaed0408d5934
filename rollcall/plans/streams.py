"""Streaming queries: the event file as a stream, run to its end."""

from pyspark.sql import functions as F

from rollcall.functions import spread
from rollcall.plans.policies import disp_sql
from rollcall.plans.registry import query, rounded
from rollcall.sources.domain import VIEW_SQL, Domain
from rollcall.sources.readers import work_folder
from rollcall.streaming import jobs


def path(d: Domain) -> str:
    return f"{d.folder}/events*.parquet"


_WM = "(SELECT max(ts)-INTERVAL 1 HOUR AS wm FROM events)"


@query("stream_velocity", f"""SELECT state, start, events, round(total,4) AS total FROM (SELECT n_name AS state, date_trunc('day', ts)::TIMESTAMP AS start, date_trunc('day', ts)::TIMESTAMP AS s, count(*) AS events, sum(value) AS total
 FROM events JOIN nation ON user_id%25=n_nationkey GROUP BY 1,2,3), {_WM} WHERE s+INTERVAL 1 DAY<=wm""")
def stream_velocity(d: Domain):
    """Stream joined with the static region table, daily windows."""
    ev = jobs.read_events(d.spark, path(d)).withColumn("k", (F.col("user_id") % 25).cast("int"))
    ev = ev.join(d.table("nation").select("n_nationkey", F.col("n_name").alias("state")), F.col("k") == F.col("n_nationkey"))
    return rounded(jobs.run_to_table(jobs.stream_velocity(ev, "state"), "velocity"), 4)


@query("stream_moving_mean", f"""SELECT event_type, s::TIMESTAMP AS start, (s+INTERVAL 7 DAY)::TIMESTAMP AS end, round(mean_value,6) AS mean_value, n FROM (SELECT event_type, s, avg(value) AS mean_value, count(*) AS n FROM events,
 (SELECT unnest(generate_series(0,6)) AS o), LATERAL (SELECT date_trunc('day', ts)::TIMESTAMP-to_days(CAST(o AS INT)) AS s) GROUP BY 1,2), {_WM} WHERE s+INTERVAL 7 DAY<=wm""")
def stream_moving_mean(d: Domain):
    return rounded(jobs.run_to_table(jobs.stream_moving_mean(jobs.read_events(d.spark, path(d)), "event_type"), "mean"))


@query("stream_sessions", f"""SELECT user_id, s::TIMESTAMP AS start, e::TIMESTAMP AS end, events FROM (SELECT user_id, min(ts) AS s, max(ts)+INTERVAL 30 MINUTE AS e, count(*) AS events FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
 SELECT *, CASE WHEN ts-lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)<INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g), {_WM} WHERE e<=wm""")
def stream_sessions(d: Domain):
    return jobs.run_to_table(jobs.stream_sessions(jobs.read_events(d.spark, path(d)), "user_id"), "sessions")


VIEW_SQL["drift"] = """SELECT key, n, n=2000 AS enough, CASE WHEN n=2000 THEN round(hm,6) END AS historical_mean, CASE WHEN n=2000 THEN round(rm,6) END AS recent_mean, CASE WHEN n=2000 THEN round(m,6) END AS magnitude,
 n=2000 AND coalesce(m>0.1e0, false) AS is_drift FROM (SELECT *, (abs(rm-hm)+abs(rs-hs))/2e0 AS m FROM (
 SELECT event_type AS key, count(*) AS n, avg(value) FILTER (WHERE rn>1000) AS hm, stddev_pop(value) FILTER (WHERE rn>1000) AS hs, avg(value) FILTER (WHERE rn<=1000) AS rm, stddev_pop(value) FILTER (WHERE rn<=1000) AS rs FROM (
 SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn<=2000 GROUP BY 1))"""


@query("batch_drift", "SELECT * FROM drift")
def batch_drift(d: Domain):
    return rounded(jobs.batch_drift(d.events(), "event_type", "ts", "event_id", "value").withColumnRenamed("event_type", "key"))


@query("stream_drift", "SELECT * FROM drift")
def stream_drift(d: Domain):
    """Windows of 1000 scores and a cut of 0.1; keys with too few events are flagged."""
    return rounded(jobs.stream_drift(jobs.read_events(d.spark, path(d)), "event_type", "event_id", "value"))


@query("stream_policy", f"""SELECT event_id, round(score,6) AS score, {disp_sql('balanced')} AS disposition FROM (SELECT event_id, least(1e0, abs((value-m)/s)/3e0) AS score FROM events, (SELECT avg(value) m, stddev_pop(value) s FROM events))""")
def stream_policy(d: Domain):
    """Statistics fitted in batch, applied to the stream."""
    fit = d.events().agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).first()
    s = jobs.score_on_arrival(jobs.read_events(d.spark, path(d)), fit["m"], fit["s"]).select("event_id", "score", "disposition")
    return rounded(jobs.run_to_table(s, "policy"))


@query("stream_late", "SELECT event_id, ts::TIMESTAMP AS ts, user_id FROM events")
def stream_late(d: Domain):
    """Events replayed as two streams, the second repeating the last hour of the first."""
    folder = work_folder(d.spark, "replay")
    e = d.table("events").select("event_id", "ts", "user_id")
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    mid = F.lit(span["a"] + (span["b"] - span["a"]) / 2).cast("timestamp_ntz")
    e.filter(F.col("ts") < mid).repartitionByRange("ts").write.parquet(f"{folder}/first")
    e.filter(F.col("ts") >= mid - F.expr("interval 1 hour")).repartitionByRange("ts").write.parquet(f"{folder}/second")
    # one file stream per half; both feed one state, so what the halves share comes out once
    halves = [jobs.read_events(d.spark, f"{folder}/{half}") for half in ("first", "second")]
    return jobs.run_to_table(jobs.stream_late(halves[0].unionByName(halves[1]), "event_id"), "late")


@query("refresh_snapshot", "SELECT event_type, count(*) AS events, round(sum(value),4) AS total, max(ts)::TIMESTAMP AS last_ts FROM events GROUP BY 1")
def refresh_snapshot(d: Domain):
    return rounded(jobs.refresh_snapshot(jobs.read_events(d.spark, path(d)), "event_type"), 4)
