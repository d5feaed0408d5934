"""Policies, requests, strategies, unified risk, report tables."""

from pyspark.sql import functions as F

from rollcall.functions import tables
from rollcall.operators import aggregate, explain, policy
from rollcall.plans import views
from rollcall.plans.explaining import FEATS, KEY, feats
from rollcall.plans.ordering import requests
from rollcall.plans.registry import query, rounded
from rollcall.sources import readers
from rollcall.sources.domain import VIEW_SQL, Domain


def disp_sql(tolerance: str, s: str = "score") -> str:
    r, f, e = tables.POLICY_CUTS[tolerance]
    return f"CASE WHEN {s}>={e}e0 THEN 'ESCALATE' WHEN {s}>={f}e0 THEN 'FLAG' WHEN {s}>={r}e0 THEN 'REVIEW' ELSE 'CLEAR' END"


@query("policy_disposition", "SELECT order_id, line_no, " + ", ".join(f"{disp_sql(t)} AS {t}" for t in tables.POLICY_CUTS) + " FROM scored")
def policy_disposition(d: Domain):
    s = views.scored(d)
    return s.select("order_id", "line_no", *[policy.disposition(F.col("score"), t).alias(t) for t in tables.POLICY_CUTS])


def _map_sql(table: dict, key: str, other: str) -> str:
    q = lambda v: f"{v}::BIGINT" if isinstance(v, int) else f"'{v}'"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {q(v)}" for k, v in table.items()) + f" ELSE {other} END"


VIEW_SQL["prec"] = f"""SELECT *, concat_ws('|', disposition, indicator) AS pair FROM (SELECT rid, order_id, line_no, score, is_weekend, total_demo_updates, {disp_sql('balanced')} AS disposition,
 CASE WHEN score>=0.8e0 THEN 'Critical' WHEN score>=0.6e0 THEN 'High' WHEN score>=0.4e0 THEN 'Medium' ELSE 'Low' END AS indicator FROM feats)"""
_WORD = _map_sql(policy.POLICY_WORDS, "feature", "'operational metric'")


@query("policy_records", f"""SELECT p.order_id, p.line_no, disposition, indicator, CASE WHEN p.score>=0.7e0 THEN 'Very High' WHEN p.score>=0.4e0 THEN 'High' ELSE 'Standard' END AS confidence_level, disposition IN ('FLAG','ESCALATE') AS requires_action,
 {_map_sql(policy.PRIORITY, 'pair', '4')} AS action_priority, {_map_sql(policy.AUTHORITY, 'disposition', 'NULL')} AS review_by, {_map_sql(policy.ACTIONS, 'pair', f"'{policy.DEFAULT_ACTION}'")} AS action,
 concat_ws('|', CASE WHEN p.score>=0.9e0 THEN 'CRITICAL_DEVIATION' WHEN p.score>=0.7e0 THEN 'SIGNIFICANT_DEVIATION' END, CASE WHEN is_weekend=1 THEN 'WEEKEND_ACTIVITY' END, CASE WHEN total_demo_updates>200 THEN 'HIGH_VOLUME' END) AS flags,
 CASE disposition WHEN 'CLEAR' THEN 'Record aligns with expected operational patterns.' WHEN 'ESCALATE' THEN concat('Critical deviation detected in ',{_WORD},'. Immediate review required.') WHEN 'FLAG' THEN concat('Significant deviation in ',{_WORD},' warrants investigation.')
 ELSE concat('Minor deviation in ',{_WORD},' recommended for review.') END AS reason FROM prec p JOIN attr a ON p.rid=a.rid AND a.rn=1""")
def policy_records(d: Domain):
    a = explain.attribution(feats(d), FEATS, 3)
    r = policy.policy_records(a, "score", "STANDARD", "total_demo_updates", "contributors")
    return r.select(*KEY, "disposition", "indicator", "confidence_level", "requires_action", "action_priority", "review_by", "action", F.array_join("flags", "|").alias("flags"), "reason")


_SUMMARY = f"""SELECT *, (escalate+flag)/total::DOUBLE AS rate FROM (SELECT count(*) AS total, count(*) FILTER (WHERE d='ESCALATE') AS escalate, count(*) FILTER (WHERE d='FLAG') AS flag, count(*) FILTER (WHERE d='REVIEW') AS review,
 count(*) FILTER (WHERE d='CLEAR') AS clear FROM (SELECT {disp_sql('balanced')} AS d FROM scored))"""


@query("policy_summary", f"""SELECT total, escalate, flag, review, clear, round(rate,6) AS critical_rate, CASE WHEN rate>0.2e0 THEN 'HIGH - Immediate attention required' WHEN rate>0.1e0 THEN 'ELEVATED - Enhanced monitoring recommended'
 WHEN rate>0.05e0 THEN 'MODERATE - Standard monitoring sufficient' ELSE 'LOW - Normal operations' END AS assessment, concat_ws('|', CASE WHEN escalate>0 THEN concat('URGENT: ',escalate,' records require immediate escalation to senior authority') END,
 CASE WHEN flag>0 THEN concat('Assign ',flag,' flagged records to investigation team') END, CASE WHEN review>0 THEN concat('Schedule review batch for ',review,' records') END, CASE WHEN clear>0 THEN concat(clear,' records cleared for standard processing') END,
 'Generate compliance report for audit trail') AS next_steps FROM ({_SUMMARY})""")
def policy_summary(d: Domain):
    s = policy.policy_summary(policy.policy_records(views.scored(d), "score"))
    return rounded(s.withColumn("next_steps", F.array_join("next_steps", "|")))


_AUDIT = " UNION ALL ".join(f"SELECT '{p}' AS policy_id, 'system' AS user_id, '2001-08-01' AS at, count(*) AS records_processed, count(*) FILTER (WHERE {disp_sql(t)} IN ('FLAG','ESCALATE')) AS flags_raised FROM scored"
                            for p, t in tables.POLICY_PRESETS.items())


def _audited(d: Domain, runs: int = 1) -> str:
    s = views.scored(d)
    path = readers.work_folder(d.spark, "audit")
    for _ in range(runs):
        for p in tables.POLICY_PRESETS:
            policy.append_audit(policy.audit_rows(policy.policy_records(s, "score", p), p, "system", "2001-08-01"), path)
    return path


@query("audit_log", _AUDIT)
def audit_log(d: Domain):
    """Append-only audit rows, one per policy run, read back."""
    return d.spark.read.parquet(_audited(d))


@query("compliance_summary", f"SELECT policy_id, CAST(2 AS BIGINT) AS audit_entries, records_processed*2 AS records_processed, flags_raised*2 AS flags_raised FROM ({_AUDIT})")
def compliance_summary(d: Domain):
    return aggregate.compliance_summary(d.spark.read.parquet(_audited(d, 2)))


# ---------------------------------------------------------------- requests and strategies

_W = tables.values_sql(tables.SIGNAL_WEIGHTS)


@query("resolve_signals", f"""SELECT event_id, signal, round(CASE WHEN vigilance='maximum' THEN least(1e0,w2*1.15e0) ELSE w2 END,6) AS weight FROM (SELECT event_id, vigilance, signal, CASE WHEN has_location AND signal='geographic_distribution' THEN least(1e0,w*1.2e0)
 WHEN is_today AND signal='temporal_patterns' THEN least(1e0,w*1.1e0) ELSE w END AS w2 FROM requests JOIN (SELECT i.k AS intent, i.v AS signal, x.v AS w FROM {tables.values_sql(tables.INTENT_SIGNALS)} i(k,v) JOIN {_W} x(k,v) ON i.v=x.k) USING (intent))""")
def resolve_signals(d: Domain):
    return rounded(policy.resolve_signals(requests(d), ["event_id"]))


_REACH = "(VALUES " + ",".join(f"('{intent}', '{strategy}', {(i + 1) * 100 + j})" for intent, signals in tables.INTENT_SIGNALS.items()
                              for i, signal in enumerate(signals) for j, strategy in enumerate(tables.SIGNAL_STRATEGIES.get(signal, ()))) + ")"


@query("recommend_strategies", f"""SELECT event_id, rn AS rank, strategy, score, CASE WHEN score>=2 THEN 'High' ELSE 'Standard' END AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, o) AS rn FROM (
 SELECT event_id, strategy, min(pos) AS o, sum(p)::DOUBLE AS score FROM (SELECT event_id, r.strategy, 1e0 AS p, r.pos FROM requests JOIN {_REACH} r(k, strategy, pos) ON intent=r.k
  UNION ALL SELECT event_id, v.strategy, 0.5e0, v.pos FROM requests, (VALUES ('pattern_consistency', 1000001), ('cross_reference', 1000002)) v(strategy, pos) WHERE vigilance IN ('enhanced','maximum')) GROUP BY 1,2)) WHERE rn<=3
 UNION ALL SELECT event_id, 1, 'behavioral_baseline', 0e0, 'Standard' FROM requests WHERE vigilance NOT IN ('enhanced','maximum') AND intent IS NULL""")
def recommend_strategies(d: Domain):
    return policy.recommend_strategies(requests(d), ["event_id"])


def _run_sql(strategy: str, vigilance: str) -> str:
    method, conf, names = tables.STRATEGY_METHODS[strategy]
    c = "CASE WHEN score>=0.5e0 THEN 1e0 ELSE 0e0 END" if method == "voting" else "score"
    m = tables.VIGILANCE_CUT[vigilance]
    return (f"SELECT '{strategy}' AS strategy, '{'|'.join('zscore' for _ in names)}' AS techniques, '{vigilance}' AS vigilance, '{'High' if conf >= 0.7 else 'Standard'}' AS confidence, count(*) AS records_analyzed, "
            f"count(*) FILTER (WHERE c>={m * 0.5!r}::DOUBLE) AS flagged, count(*) FILTER (WHERE c>={m * 0.3!r}::DOUBLE AND c<{m * 0.5!r}::DOUBLE) AS review, count(*) FILTER (WHERE c<{m * 0.3!r}::DOUBLE) AS cleared, round(avg(c),6) AS raw_score FROM (SELECT {c} AS c FROM scored)")


_RUNS = [("volume_surge", "standard"), ("behavioral_baseline", "enhanced"), ("pattern_consistency", "maximum"), ("temporal_trend", "routine")]


@query("run_strategy", " UNION ALL ".join(_run_sql(s, v) for s, v in _RUNS))
def run_strategy(d: Domain):
    from functools import reduce
    demo = d.demographic()
    parts = [policy.run_strategy(demo, s, ["demo_age_5_17", "demo_age_17_"], v) for s, v in _RUNS]
    return rounded(reduce(lambda a, b: a.unionByName(b), parts))


VIEW_SQL["souts"] = """SELECT state, strategy, raw_score, confidence, n AS records_analyzed FROM (SELECT state, count(*) AS n, avg(score) AS a, count(*) FILTER (WHERE score>=0.5e0)/count(*)::DOUBLE AS r, max(score) AS m, avg(is_weekend) AS w FROM scored GROUP BY 1),
 LATERAL (VALUES ('behavioral_baseline', a, 0.7e0), ('volume_surge', r, 0.6e0), ('pattern_consistency', m, 0.75e0), ('temporal_trend', w, 0.6e0)) v(strategy, raw_score, confidence)"""


def strategy_outputs(d: Domain):
    """Four strategy results per state."""
    g = views.scored(d).groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.avg("score").alias("a"), (F.count_if(F.col("score") >= 0.5) / F.count(F.lit(1))).alias("r"),
                                             F.max("score").alias("m"), F.avg("is_weekend").alias("w"))
    rows = F.array(*[F.struct(F.lit(s).alias("strategy"), F.col(c).alias("raw_score"), F.lit(k).alias("confidence")) for s, c, k in (
        ("behavioral_baseline", "a", 0.7), ("volume_surge", "r", 0.6), ("pattern_consistency", "m", 0.75), ("temporal_trend", "w", 0.6))])
    return g.select("state", F.col("n").alias("records_analyzed"), F.explode(rows).alias("e")).select("state", "records_analyzed", "e.*")


_UW = "CASE strategy " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in tables.STRATEGY_WEIGHTS.items()) + " ELSE 0.15e0 END"


@query("unified_risk", f"""SELECT state, strategies, records, risk_index, CASE WHEN risk_index<=30 THEN 'Low' WHEN risk_index<=60 THEN 'Medium' WHEN risk_index<=85 THEN 'High' ELSE 'Critical' END AS risk_level, round(c,6) AS confidence,
 CASE WHEN c<0.4e0 THEN 'Low' WHEN c<0.6e0 THEN 'Moderate' WHEN c<0.8e0 THEN 'High' ELSE 'Very High' END AS confidence_level FROM (SELECT state, count(*) AS strategies, CAST(sum(records_analyzed) AS BIGINT) AS records,
 CAST(round_even(least(1e0, sum(raw_score*{_UW})/sum({_UW})*1.15e0)*100e0, 0) AS BIGINT) AS risk_index, least(1e0, greatest(0e0, avg(confidence)+least(0.15e0, count(*)*0.03e0)-CASE WHEN sum(records_analyzed)<100 THEN 0.1e0 WHEN sum(records_analyzed)<500 THEN 0.05e0 ELSE 0e0 END)) AS c FROM souts GROUP BY 1)""")
def unified_risk(d: Domain):
    return rounded(policy.unified_risk(strategy_outputs(d), ["state"], "enhanced"))


def _obs(i: int) -> str:
    t = "CASE strategy " + " ".join(f"WHEN '{k}' THEN '{v[i]}'" for k, v in policy.OBSERVATIONS.items()) + f" ELSE '{policy.OTHER_OBSERVATION[i]}' END"
    return f"replace(replace({t}, '{{loc}}', state), '{{pct}}', CAST(CAST(floor(raw_score*100) AS BIGINT) AS VARCHAR))"


@query("observations", f"SELECT state, strategy, {_obs(0)} AS observation, {_obs(1)} AS title, {_obs(2)} AS description, CASE WHEN raw_score>0.7e0 THEN 'Significant' WHEN raw_score>0.4e0 THEN 'Moderate' ELSE 'Minor' END AS severity FROM souts")
def observations(d: Domain):
    return policy.observations(strategy_outputs(d), "strategy", "raw_score", "state").select("state", "strategy", "observation", "title", "description", "severity")


# ---------------------------------------------------------------- reports

@query("system_confidence", """SELECT round(ag*0.4e0+q*0.3e0+0.5e0*0.2e0+(1e0-sd)*0.1e0,6) AS overall_confidence, round(ag,6) AS model_agreement, round(q,6) AS data_quality, 0.5e0 AS coverage FROM (SELECT greatest(0.5e0, 1e0-((f0-m)**2+(f1-m)**2)/2e0/(m+1e0)) AS ag,
 1e0-nulls/(n*8) AS q, sd FROM (SELECT *, (f0+f1)/2e0 AS m FROM (SELECT count(*)::DOUBLE AS n, (count(*)-count(s2))::DOUBLE AS nulls, stddev_pop(score) AS sd, (count(*) FILTER (WHERE score>=0.5e0))::DOUBLE AS f0, (count(*) FILTER (WHERE s2>=0.5e0))::DOUBLE AS f1 FROM feats)))""")
def system_confidence(d: Domain):
    s = views.scored(d)
    s = s.withColumn("s2", F.when(F.col("order_id") % 5 != 0, F.col("demo_age_5_17") % 11 / 10.0)).select("order_id", "line_no", "state", "month", "center_id", "operator_id", "score", "s2")
    return rounded(policy.system_confidence(s, "score", [F.col("score") >= 0.5, F.col("s2") >= 0.5]))


VIEW_SQL["astat"] = """SELECT count(*) AS total, count(*) FILTER (WHERE score>=0.5e0) AS anomaly_count, count(*) FILTER (WHERE score>=0.8e0) AS high_risk, count(*) FILTER (WHERE score>=0.5e0)*100e0/count(*) AS pct FROM scored"""
_VALUE = "CASE WHEN high_risk*50000>=10000000 THEN printf('₹%.1f Crore', high_risk*50000/1e7) WHEN high_risk*50000>=100000 THEN printf('₹%.1f Lakh', high_risk*50000/1e5) ELSE format('₹{:,}', high_risk*50000) END"
_URG = "CASE WHEN high_risk>100 OR pct>10 THEN 'CRITICAL' WHEN high_risk>50 OR pct>5 THEN 'HIGH' WHEN high_risk>20 OR pct>2 THEN 'MEDIUM' ELSE 'LOW' END"


@query("policy_impact", f"""SELECT high_risk, anomaly_count, high_risk*50000 AS value, {_VALUE} AS value_text, CAST(floor(anomaly_count*2.5e0) AS BIGINT) AS people, CASE WHEN floor(anomaly_count*2.5e0)>=100000 THEN printf('~%.1f Lakh individuals', floor(anomaly_count*2.5e0)/1e5)
 ELSE format('~{{:,}} individuals', CAST(floor(anomaly_count*2.5e0) AS BIGINT)) END AS people_text, {_URG} AS urgency FROM astat""")
def policy_impact(d: Domain):
    return policy.policy_impact(aggregate.anomaly_statistics(views.scored(d)))


@query("fraud_report", f"""SELECT concat_ws(chr(10), 'Demographic updates', printf('%.1f%% of records flagged as potentially fraudulent', pct), format('Detected {{:,}} potentially fraudulent records out of {{:,}}', anomaly_count, total),
 concat('Highest risk regions: ', (SELECT string_agg(state, ', ' ORDER BY risk DESC, state) FROM (SELECT state, avg(score)*0.6e0+count(*) FILTER (WHERE score>=0.5e0)/count(*)::DOUBLE*0.4e0 AS risk FROM scored GROUP BY 1 ORDER BY risk DESC, state LIMIT 3))),
 concat('Temporal spikes detected in: ', coalesce((SELECT string_agg(concat('Month ', month), ', ' ORDER BY month) FROM (SELECT month, r, avg(r) OVER () AS m FROM (SELECT month, count(*) FILTER (WHERE score>=0.5e0)/count(*)::DOUBLE AS r FROM scored GROUP BY 1)) WHERE r>m*1.5e0), 'No significant spikes')),
 concat('Value at stake: ', {_VALUE}), concat('Urgency: ', {_URG})) AS report_text, total AS total_records, anomaly_count FROM astat""")
def fraud_report(d: Domain):
    return policy.fraud_report(views.scored(d), "Demographic updates").select("report_text", "total_records", "anomaly_count")


@query("sanity_checklist", """SELECT 'Gender columns' AS item, 'ok' AS status, 'Male and female enrollment data available' AS message UNION ALL SELECT 'District data', 'ok', concat(count(DISTINCT district), ' unique districts found') FROM coverage
 UNION ALL SELECT 'Missing values', 'ok', 'No missing values detected' UNION ALL SELECT 'Coverage ratio', CASE WHEN count(*) FILTER (WHERE female_ratio<0 OR female_ratio>1)>0 THEN 'error' ELSE 'ok' END, 'All coverage ratios within valid range [0, 1]' FROM coverage""")
def sanity_checklist(d: Domain):
    return policy.sanity_checklist(views.coverage(d), "female_ratio")
